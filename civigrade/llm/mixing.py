"""Mixing sources to target weights by temperature.

The weight of a source is its share of the tokens to the power of an exponent, normalised. Exponent 1 keeps the natural shares,
smaller ones level them. The exponent is found by bisection, either for a target entropy of the weights or for a repetition limit:
the number of epochs over the source that is repeated most. Each step of the bisection is an aggregate over the table of sources, for
several exponents at once, so the sources never have to fit anywhere.

Weights are then realised against a token budget. Every source is cut into at most ``BLOCKS`` blocks by a hash of its rows, and each
epoch is a permutation of the blocks. A source gets its whole epochs, and of the last one the blocks that fit in front; the block
that crosses the budget is cut between documents, so a source exceeds or misses its budget by less than one document.

Without a budget the least one is taken that lets every source come at least once: nothing is dropped then, and no source is
repeated more often than the limit. Only sums per source and per block meet in one place, and the one crossing block per source.

Defined results: a null source is a source; a null or empty text has no tokens, counts in no share, and comes once per whole epoch;
equal rows are drawn like any others; an empty table gives no rows; added columns that clash are refused.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civigrade.llm import spans
from civigrade.llm.blocks import pack
from civigrade.session import materialise

BLOCKS = 1_024
GRID = 24
ROUNDS = 9
LOWEST, HIGHEST = 0.0, 1.0
REPETITION_LIMIT = 1.25
SEED = 17


def words_in(text: Column) -> Column:
    """Number of maximal runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_totals(rows: DataFrame) -> DataFrame:
    """Tokens and documents per source; sources without a token have no share."""
    return rows.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))


def measured(sources: DataFrame, exponents: list[float], goal: str) -> list[float]:
    """Entropy of the weights, or epochs of the most repeated source when the least repeated one comes once, per exponent."""
    share = F.log(F.col("source_tokens") / F.col("all_tokens"))
    facts = []
    for i, exponent in enumerate(exponents):
        power = F.exp(share * exponent)
        if goal == "entropy":
            facts += [F.sum(power).alias(f"z{i}"), F.sum(power * share * exponent).alias(f"t{i}")]
        else:
            # Epochs are in proportion to share ** (exponent - 1).
            ratio = F.exp(share * (exponent - 1.0))
            facts.append((F.max(ratio) / F.min(ratio)).alias(f"r{i}"))
    row = sources.filter("source_tokens > 0").agg(*facts).first()
    if goal == "entropy":
        return [math.log(row[f"z{i}"]) - row[f"t{i}"] / row[f"z{i}"] if row[f"z{i}"] else 0.0 for i in range(len(exponents))]
    return [row[f"r{i}"] if row[f"r{i}"] is not None else 1.0 for i in range(len(exponents))]


def exponent_for(sources: DataFrame, goal: str, target: float) -> float:
    """The greatest exponent from 0 to 1 whose entropy reaches the target, or the least whose repetition stays within it.

    Both fall as the exponent grows. Each round cuts the interval at ``GRID`` points in one aggregate and keeps one piece.
    """
    low, high = LOWEST, HIGHEST
    at_low, at_high = measured(sources, [low, high], goal)
    if goal == "entropy" and at_high >= target or goal == "repetition" and at_low <= target:
        return high if goal == "entropy" else low
    if goal == "entropy" and at_low <= target:
        return low
    if goal == "repetition" and at_high >= target:
        return high
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        values = measured(sources, points, goal)
        above = max(i for i, value in enumerate(values) if value >= target or i == 0)
        low, high = points[above], points[min(above + 1, GRID)]
    return low if goal == "entropy" else high


def plan(rows: DataFrame, goal: str, target: float, budget: int | None) -> DataFrame:
    """One written row per source: source_tokens, weight, source_budget and epochs."""
    totals = materialise(source_totals(rows), "sources")
    all_tokens = totals.agg(F.sum("source_tokens")).first()[0] or 0
    totals = totals.withColumn("all_tokens", F.lit(all_tokens).cast("long"))
    exponent = exponent_for(totals, goal, target)
    share = F.log(F.col("source_tokens") / F.col("all_tokens"))
    powers = totals.withColumn("power", F.when(F.col("source_tokens") > 0, F.exp(share * exponent)))
    sums = powers.agg(F.sum("power").alias("z"), F.max(F.col("source_tokens") / F.col("power")).alias("most")).first()
    if budget is None:
        budget = (sums["most"] or 0.0) * (sums["z"] or 0.0)
    weight = F.coalesce(F.col("power") / F.lit(sums["z"] or 1.0), F.lit(0.0))
    # Rounded, or a source that comes exactly once could lose its last document to the last bit of a product.
    epochs = F.when(F.col("source_tokens") > 0, F.round(F.col("weight") * budget / F.col("source_tokens"), 9)).otherwise(1.0)
    shares = powers.withColumns({"weight": weight, "exponent": F.lit(exponent)}).drop("power", "all_tokens")
    return materialise(shares.withColumns({"source_budget": F.col("weight") * float(budget), "epochs": epochs}), "source-plan")


def block_order(epoch: Column) -> Column:
    """The key that permutes the blocks of a source, another one each epoch."""
    return F.xxhash64(F.lit(SEED), "source", epoch, "draw_block")


def decisions(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Which blocks come in which epoch: draw_source, draw_block, epoch, block_rank and ``left`` (tokens wanted of a crossing block).

    Windows hold the blocks of one source, at most ``BLOCKS``.
    """
    sums = rows.groupBy("source", "draw_block").agg(F.sum("n_tokens").alias("block_tokens"))
    own = sources.select(F.col("source").alias("draw_source"), "source_tokens", "weight", "epochs", "exponent")
    blocks = sums.join(own, F.col("source").eqNullSafe(F.col("draw_source")))
    epochs = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil("epochs").cast("int") - 1)))
    order = Window.partitionBy("source", "epoch").orderBy(block_order(F.col("epoch")), "draw_block")
    wanted = F.least(F.col("epochs") - F.col("epoch"), F.lit(1.0)) * F.col("source_tokens")
    ranked = epochs.withColumns(
        {"block_rank": F.row_number().over(order) - 1, "before": F.sum("block_tokens").over(order) - F.col("block_tokens"), "wanted": wanted}
    )
    whole = (F.col("epochs") >= F.col("epoch") + 1) | (F.col("before") + F.col("block_tokens") <= F.col("wanted"))
    left = F.when(~whole, F.col("wanted") - F.col("before"))
    taken = ranked.filter(whole | (F.col("before") < F.col("wanted"))).withColumn("left", left)
    return taken.select("draw_source", F.col("draw_block").alias("of_block"), "weight", "epochs", "epoch", "block_rank", "left")


def drawn(rows: DataFrame, goal: str = "repetition", target: float = REPETITION_LIMIT, budget: int | None = None) -> DataFrame:
    """One row per copy that the mixture holds: the columns of ``rows`` with weight, epochs, epoch, block_rank and place_key.

    ``rows`` has source, n_tokens and draw_key (a hash that tells rows apart). The sequence is by epoch, block_rank and place_key.
    """
    rows = materialise(rows.withColumn("draw_block", F.pmod("draw_key", F.lit(BLOCKS))), "draw-rows")
    blocks = materialise(decisions(rows, plan(rows, goal, target, budget)), "draw-blocks")
    same = F.col("source").eqNullSafe(F.col("draw_source")) & (F.col("draw_block") == F.col("of_block"))
    place = F.xxhash64(F.lit(SEED), "epoch", "draw_key")
    whole = rows.join(blocks.filter("left IS NULL"), same).withColumn("place_key", place)
    crossing = rows.join(blocks.filter("left IS NOT NULL"), same).withColumn("place_key", place)
    order = Window.partitionBy("source", "epoch").orderBy("place_key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_tokens").over(order), F.lit(0))
    crossing = crossing.withColumn("before", before).filter(F.col("before") < F.col("left")).drop("before")
    return whole.unionByName(crossing).drop("draw_source", "of_block", "left", "draw_block")


def mixture(docs: DataFrame, goal: str = "repetition", target: float = REPETITION_LIMIT, budget: int | None = None) -> DataFrame:
    """Whole rows of ``docs`` as often as the mixture holds them; texts are packed once and not shuffled."""
    blocks = pack(docs)

    def measure(block: int, rows: pa.Table) -> pa.Table:
        counts = [np.zeros(0, np.int64)]
        for batch in spans.sliced(rows.select(["text"]).to_batches(), "text"):
            of_row = spans.words(*spans.buffers(batch.column("text")))[2]
            counts.append(np.bincount(of_row, minlength=batch.num_rows))
        counts = np.concatenate(counts)
        columns = {"block": pa.array(np.full(len(counts), block)), "place": pa.array(np.arange(len(counts)))}
        return pa.table({**columns, "source": rows["source"].cast(pa.string()), "n_tokens": pa.array(counts)})

    rows = blocks.each(measure, "block long, place long, source string, n_tokens long")
    return blocks.chosen(drawn(rows.withColumn("draw_key", F.xxhash64("block", "place")), goal, target, budget).select("block", "place"))
