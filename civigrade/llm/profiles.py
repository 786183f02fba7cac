"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams in order of frequency. A document is ranked in the same way, and its
distance to a profile is the sum over its n-grams of how far each is out of place; n-grams that the profile lacks count the most.
The language with the least distance wins.

Training counts run over every training document: each task adds up its own documents per language and n-gram, then one aggregate
adds up the tasks. A profile has a fixed number of n-grams, so the profiles of at most ``MAX_LANGUAGES`` languages are what is
broadcast; more languages are refused.

Letters are folded to lower case, everything else counts as one blank between words, and n-grams cross no blank. Defined results:
a text that is null or has no letter is ``und`` with score 0; equal distances go to the smallest language name, equal frequencies to
the smallest n-gram; training rows with a null language or text teach nothing; without any profile every row is ``und``; columns
with the names of the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from civigrade.llm import spans
from civigrade.llm.blocks import unused

ORDERS = (1, 2, 3)
PROFILE = 300
MAX_LANGUAGES = 2_000
UNKNOWN = "und"
POINTS = 0x110000
#: Three code points of 21 bits in one number; the blank is code point 0x20.
SHIFT = np.uint64(21)
ROW_SHIFT = np.uint64(63)

_folding: list[np.ndarray] = []


def folding() -> np.ndarray:
    """For every code point its lower-case letter, or a blank; made once per worker from Python's Unicode tables."""
    if not _folding:
        folded = np.full(POINTS, 0x20, dtype=np.uint64)
        for point in range(POINTS):
            letter = chr(point)
            if letter.isalpha():
                low = letter.lower()
                folded[point] = ord(low) if len(low) == 1 and low.isalpha() else point
        _folding.append(folded)
    return _folding[0]


def points_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts, each between blanks and without repeated blanks, and the row of each point."""
    together = np.frombuffer("".join(f" {text or ''} " for text in texts).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(text or "") + 2 for text in texts], dtype=np.int64)
    rows = np.repeat(np.arange(len(texts)), lengths)
    points = folding()[together]
    blank = points == 0x20
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (rows[1:] == rows[:-1]))
    return points[keep], rows[keep]


def grams_of(points: np.ndarray, rows: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of one order as numbers, and their rows: no blank inside, and not blanks alone."""
    size = len(points) - order + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(size, dtype=np.uint64)
    good = rows[:size] == rows[order - 1 :]
    for step in range(order):
        part = points[step : step + size]
        value = (value << SHIFT) | part
        if 0 < step < order - 1 or order == 1:
            good &= part != 0x20
    return value[good], rows[:size][good]


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram (its place in the returned sorted names), count, and names: every distinct n-gram of every text, in order."""
    points, rows = points_of(texts)
    parts = [grams_of(points, rows, order) for order in ORDERS]
    of_row = np.concatenate([p[1] for p in parts]).astype(np.uint64)
    # Three code points fill 63 bits, so the row cannot share the number: the n-grams of the slice get short names first.
    encoded = pa.array(np.concatenate([p[0] for p in parts])).dictionary_encode()
    names = encoded.dictionary.to_numpy()
    order = np.argsort(names)
    short = np.empty(len(names), dtype=np.uint64)
    short[order] = np.arange(len(names), dtype=np.uint64)
    width = np.uint64(max(len(names), 1))
    keys = np.sort(of_row * width + short[encoded.indices.to_numpy()])
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    found = keys[heads]
    return (found // width).astype(np.int64), (found % width).astype(np.int64), np.diff(np.append(heads, len(keys))), names[order]


def top_ranks(rows: np.ndarray, grams: np.ndarray, counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``limit`` most frequent n-grams of each row with their rank from 0."""
    if not len(rows):
        return rows, grams, counts
    most, width = int(counts.max()), int(grams.max()) + 1
    if (int(rows.max()) + 1) * (most + 1) * width < 1 << 63:  # one number holds all three, which sorts much faster
        keys = np.sort((rows * (most + 1) + (most - counts)) * width + grams)
        rows, grams = keys // (width * (most + 1)), keys % width
    else:
        order = np.lexsort((grams, -counts, rows))
        rows, grams = rows[order], grams[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    near = rank < limit
    return rows[near], grams[near], rank[near]


def learned(train: DataFrame, limit: int = PROFILE) -> dict[str, list[int]]:
    """The profile of each language of ``train`` (text, lang): its most frequent n-grams in order."""
    usable = train.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.make_valid_utf8("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.sliced(batches, "text"):
            rows, grams, counts, names = counted(batch.column("text").to_pylist())
            langs, of_row = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object), return_inverse=True)
            keys = of_row[rows] * len(names) + grams
            order = np.argsort(keys)
            heads = np.flatnonzero(np.diff(keys[order], prepend=-1))
            totals = np.add.reduceat(counts[order], heads) if len(heads) else counts
            lang, gram = np.divmod(keys[order][heads], max(len(names), 1))
            columns = [pa.array(langs[lang].tolist(), pa.string()), pa.array(names[gram].astype(np.int64)), pa.array(totals.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

    totals = usable.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    best = totals.withColumn("place", place).filter(F.col("place") <= limit)
    rows = best.limit(MAX_LANGUAGES * limit + 1).collect()  # refused below if there are more
    if len(rows) > MAX_LANGUAGES * limit or len({r["lang"] for r in rows}) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    profiles: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Profiles:
    """All profiles as one sorted list of n-grams with the rank that each language gives them."""

    def __init__(self, profiles: dict[str, list[int]], limit: int):
        self.names, self.limit = sorted(profiles), limit
        self.grams = np.unique(np.array([g for own in profiles.values() for g in own], dtype=np.uint64))
        #: Rank of each n-gram (line) in each language (column); -1 where the profile lacks it.
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, dtype=np.int64)
        for column, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[name], dtype=np.uint64)), column] = np.arange(len(profiles[name]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        rows, short, counts, names = counted(texts)
        rows, short, rank = top_ranks(rows, short, counts, self.limit)
        if not len(rows) or not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        grams = names[short]
        place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        place = np.where(self.grams[place] == grams, place, len(self.grams))
        heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        distance = np.empty((len(heads), len(self.names)))
        for column in range(len(self.names)):
            known = self.ranks[place, column]
            distance[:, column] = np.add.reduceat(np.where(known >= 0, np.abs(known - rank), self.limit), heads)
        best = distance.argmin(axis=1)
        most = np.diff(np.append(heads, len(rows))) * self.limit
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for row, column, score in zip(rows[heads].tolist(), best.tolist(), (1 - distance.min(axis=1) / most).tolist()):
            langs[row], scores[row] = self.names[column], score
        return langs, scores


def predicted(docs: DataFrame, profiles: dict[str, list[int]], limit: int = PROFILE, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text is looked at."""
    docs = docs.drop("lang_pred", "score")
    source = unused(docs, "valid_text")
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in spans.sliced(batches, source):
            langs, scores = shared.value.predict(batch.column(source).to_pylist())
            added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")
    return docs.withColumn(source, F.make_valid_utf8(F.col(text))).mapInArrow(run, schema)
