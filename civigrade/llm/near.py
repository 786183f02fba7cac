"""Near duplicates as the pipeline drops them: SimHash, with the words of the texts to decide.

Every set of five-word shingles gets a fingerprint of 64 bits. Fingerprints within two bits meet in the sharded BK-trees of ``simhash``,
and a pair is linked if the sets agree to four fifths by their words. Two bits reach only texts that are nearly identical (at a
similarity of 0.8 fingerprints differ in about ten bits, where most pairs of unlike texts would have to be compared), so the rest of the
pairs alike to four fifths comes from ``odd``, whose docstring gives the method, the miss rates and the defined results. Both kinds of
links make the components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from civigrade.llm import odd, simhash
from civigrade.llm.blocks import Blocks

SHINGLE = 5


def simhash_links(blocks: Blocks, sets: DataFrame) -> DataFrame:
    """Links (a, b) of sets whose fingerprints are within the radius and whose words agree to four fifths."""
    where = sets.select("node", "own.block", "own.place")
    fingerprinted = simhash.row_fingerprints(blocks, where, SHINGLE)
    return odd.verified(blocks, simhash.candidate_pairs(fingerprinted), where, SHINGLE)


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest doc_id (null last), the first such if it is repeated."""
    return odd.representatives(docs, SHINGLE, simhash_links)
