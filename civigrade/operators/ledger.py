"""Fact tables in versions of slots, so that a change reads and rewrites only what it touches.

Rows are dealt to a fixed number of slots by a hash of the columns that changes come by (import and indicator). Below a root folder::

    data/commit=N/slot=K/part-*     rows of slot K as commit N left them, in key order
    commits/commit=N/part-*         the slots commit N replaced, with number of rows and digest

A reader follows the list of commits: the live version of a slot is the one of its last commit. Only the folders of live commits are
listed, and slots are partition columns, so a read of some slots opens no file of another. A writer hands in the whole new content of
the slots it touched. Slots whose digest (two sums over row hashes that no order changes) equals the listed one are not committed, so
repeating a change leaves no trace. Old versions stay readable as of their commit until they are dropped.

Writers claim the next number by creating a file that must not exist; of two that started from the same commit the second is refused
and starts again. The list and everything that comes to the driver has at most one row for each slot and commit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from civigrade.operators.joins import upsert

SLOTS = 256
COMMITS = "slot int, n long, digest string, commit long"


class Conflict(RuntimeError):
    """Somebody else has committed since the base of a change."""


@dataclass(frozen=True)
class Ledger:
    """A table of ``columns`` below ``root``; ``by`` deals rows to slots, ``order`` sorts them inside."""

    spark: SparkSession
    root: str
    columns: StructType
    by: tuple[str, ...]
    order: tuple[str, ...]
    slots: int = SLOTS
    names: list[str] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "names", [c.name for c in self.columns])

    def slot(self) -> Column:
        """The slot of a row; null keys have one too."""
        return F.pmod(F.xxhash64(*self.by), F.lit(self.slots)).cast("int")

    def slots_of(self, rows: DataFrame) -> list[int]:
        """The slots that ``rows`` (with the columns ``by``) fall into; at most as many numbers as there are slots."""
        return sorted(row[0] for row in rows.select(self.slot().alias("slot")).distinct().collect())

    def _files(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def commits(self) -> DataFrame:
        """The list of commits: slot, n, digest, commit."""
        if not self._files().exists(self._path("commits")):
            return self.spark.createDataFrame([], COMMITS)
        return self.spark.read.schema(COMMITS).parquet(f"{self.root}/commits")

    def head(self) -> int:
        """The last commit, -1 if there is none."""
        return self.commits().agg(F.coalesce(F.max("commit"), F.lit(-1))).first()[0]

    def live(self, slots: list[int] | None = None, upto: int | None = None) -> DataFrame:
        """Of each slot its last commit with its number of rows and digest, as of commit ``upto``."""
        listed = self.commits()
        if slots is not None:
            listed = listed.filter(F.col("slot").isin(slots))
        if upto is not None:
            listed = listed.filter(F.col("commit") <= upto)
        return listed.groupBy("slot").agg(F.max_by(F.struct("commit", "n", "digest"), "commit").alias("own")).select("slot", "own.*")

    def changed_since(self, commit: int) -> list[int]:
        """Slots that later commits have replaced."""
        return sorted(row[0] for row in self.commits().filter(F.col("commit") > commit).select("slot").distinct().collect())

    def read(self, slots: list[int] | None = None, upto: int | None = None) -> DataFrame:
        """The live rows, of all slots or of some."""
        by_commit: dict[int, list[int]] = {}
        for row in self.live(slots, upto).filter("n > 0").collect():
            by_commit.setdefault(row["commit"], []).append(row["slot"])
        if not by_commit:
            return self.spark.createDataFrame([], self.columns)
        own = F.lit(False)
        for commit, numbers in sorted(by_commit.items()):
            own = own | ((F.col("commit") == commit) & F.col("slot").isin(sorted(numbers)))
        schema = StructType([*self.columns]).add("commit", "long").add("slot", "integer")
        paths = [f"{self.root}/data/commit={commit}" for commit in sorted(by_commit)]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths)
        return rows.filter(own).select(*self.names)

    def _claim(self, base: int) -> int:
        """The number of the next commit, if none has been made since ``base``."""
        files = self._files()
        files.mkdirs(self._path("claims"))
        taken = [int(f.getPath().getName()) for f in files.listStatus(self._path("claims"))]
        number = max([base, *taken]) + 1
        if not files.createNewFile(self._path(f"claims/{number}")) or self.head() != base:
            raise Conflict(f"{self.root} has changed since commit {base}")
        return number

    def write(self, rows: DataFrame, touched: list[int], base: int) -> int | None:
        """Replace the slots ``touched`` by ``rows``, their whole new content; the new commit, or None if nothing has changed."""
        number = self._claim(base)
        placed = rows.select(*self.names, self.slot().alias("slot")).repartitionByRange("slot", *self.order)
        path = f"{self.root}/data/commit={number}"
        placed.sortWithinPartitions("slot", *self.order).write.partitionBy("slot").parquet(path)
        written = self.spark.read.schema(StructType([*self.columns]).add("slot", "integer")).parquet(path)
        mark = F.xxhash64(*self.names)
        digest = F.concat_ws(":", F.sum(mark.cast("decimal(38,0)")).cast("string"), F.bit_xor(F.xxhash64(mark)).cast("string"))
        now = written.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), digest.alias("digest"))
        before = self.live(touched).select("slot", F.col("n").alias("_n"), F.col("digest").alias("_digest"))
        none = F.lit(0).cast("long")
        after = now.join(before, "slot", "full").select(
            "slot", F.coalesce("n", none).alias("n"), F.coalesce("digest", F.lit("")).alias("digest"), F.coalesce("_n", none).alias("_n"), F.coalesce("_digest", F.lit("")).alias("_digest")
        )
        rows_of = after.filter("n <> _n OR digest <> _digest").select("slot", "n", "digest").collect()
        if any(row["slot"] not in set(touched) for row in rows_of):
            raise ValueError("rows outside the slots that were touched")
        if not rows_of:
            self._files().delete(self._path(f"data/commit={number}"), True)
            return None
        listed = self.spark.createDataFrame(rows_of, "slot int, n long, digest string").coalesce(1)
        listed.write.parquet(f"{self.root}/commits/commit={number}")
        return number

    def drop_versions(self, before: int) -> int:
        """Delete the data of commits under ``before`` none of whose slots is live any more; returns how many."""
        kept = {row[0] for row in self.live().select("commit").distinct().collect()}
        gone = [c for c in range(before) if c not in kept and self._files().exists(self._path(f"data/commit={c}"))]
        for commit in gone:
            self._files().delete(self._path(f"data/commit={commit}"), True)
        return len(gone)


def create(rows: DataFrame, root: str, by: tuple[str, ...], order: tuple[str, ...], slots: int = SLOTS) -> Ledger:
    """A new ledger whose first commit holds ``rows``."""
    ledger = Ledger(rows.sparkSession, root, StructType([StructField(f.name, f.dataType) for f in rows.schema]), by, order, slots)
    ledger.write(rows, list(range(slots)), -1)
    return ledger


def upsert_slots(ledger: Ledger, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> int | None:
    """Put ``incoming`` rows in by ``keys`` (which include what deals rows to slots); only their slots are read and written."""
    if not set(ledger.by) <= set(keys):
        raise ValueError("a key must tell the slot of its row")
    base, touched = ledger.head(), ledger.slots_of(incoming)
    if not touched:
        return None
    return ledger.write(upsert(ledger.read(touched, base), incoming, keys, order), touched, base)
