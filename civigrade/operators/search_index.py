"""An inverted index of character triples, so that a text search reads postings and hits instead of all rows.

Rows are numbered and cut into ranges of ``range_rows``. Below a root folder::

    rows/range=R/part-*          the rows of a range, with their number in it
    grams/bucket=B/part-*        (gram, range, members): the rows of a range whose text holds a gram, sorted by gram

A gram is three characters from every place of the text, filled up at its end, so one or two characters are the beginning of some gram.
Grams are dealt to buckets by their first character; a search names buckets and grams, so it opens the files of those buckets and skips
what the sorted grams rule out. Members of the grams asked for are intersected range by range; no list is longer than a range,
however frequent its gram. Rows are read from the ranges that have hits only. Candidates hold all grams of all words, not always the
words, so the search itself then runs on them and gives what it gives on all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from civigrade.functions.text import evaluated, parse_place_name, place_name_key, words_key
from civigrade.operators import filters, geography
from civigrade.operators.joins import number_rows

GRAM = 3
RANGE_ROWS = 65_536
BUCKETS = 64
#: Fills texts up, and stands between texts that are indexed together.
FILL, BETWEEN = "\u0000", "\u0001"
POSTINGS = "gram string, range int, members array<int>, bucket int"


def _grams(text: Column) -> Column:
    filled = F.concat(text, F.lit(FILL * (GRAM - 1)))
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text))).otherwise(F.expr("array()").cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda at: F.substring(filled, at, F.lit(GRAM))))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(F.left(gram, F.lit(1))), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class TextIndex:
    """A written index over rows of ``columns``."""

    spark: SparkSession
    root: str
    columns: StructType

    def _postings(self, words: list[str]) -> DataFrame | None:
        """(range, members) of the rows that hold all grams of all words; None if nothing is asked for."""
        words = [word for word in words if word]
        whole = sorted({word[at : at + GRAM] for word in words for at in range(len(word) - GRAM + 1)})
        starts = sorted({word for word in words if len(word) < GRAM})
        if not whole and not starts:
            return None
        buckets = evaluated(self.spark, F.array(*[_bucket(F.lit(text)) for text in [*whole, *starts]]))
        table = self.spark.read.schema(POSTINGS).parquet(f"{self.root}/grams").filter(F.col("bucket").isin(sorted(set(buckets))))
        lists = []
        if whole:
            found = table.filter(F.col("gram").isin(whole)).groupBy("range").agg(F.collect_list("members").alias("lists"))
            lists.append(found.filter(F.size("lists") == len(whole)))
        for start in starts:
            found = table.filter(F.startswith("gram", F.lit(start))).groupBy("range")
            lists.append(found.agg(F.array(F.array_distinct(F.flatten(F.collect_list("members")))).alias("lists")))
        together = lists[0]
        for more in lists[1:]:
            together = together.join(more.withColumnRenamed("lists", "more"), "range").select("range", F.concat("lists", "more").alias("lists"))
        members = F.aggregate(F.slice("lists", 2, 1 << 30), F.get("lists", F.lit(0)), lambda kept, own: F.array_intersect(kept, own))
        return together.select("range", members.alias("members")).filter(F.size("members") > 0)

    def candidates(self, words: list[str]) -> DataFrame:
        """All rows whose text holds every word, and maybe some that only hold their grams."""
        schema = StructType([*self.columns]).add("_member", "integer").add("range", "integer")
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/rows")
        hits = self._postings(words)
        if hits is None:
            return rows.select(*self.columns.names)
        hits = hits.select("range", F.explode("members").alias("_member"))
        ranges = sorted(row[0] for row in hits.select("range").distinct().collect())
        return rows.filter(F.col("range").isin(ranges)).join(hits, ["range", "_member"], "left_semi").select(*self.columns.names)


def build(rows: DataFrame, text: Column, order: str, root: str, range_rows: int = RANGE_ROWS) -> TextIndex:
    """Write the index of ``text`` over ``rows``; ``order``, a whole number that tells rows apart, numbers them."""
    spark = rows.sparkSession
    numbered = number_rows(rows.withColumns({"_text": F.coalesce(text, F.lit("")), "_order": F.col(order)}), [], "_order", [], "_number")
    at = F.col("_number") - 1
    placed = numbered.withColumns({"range": F.floor(at / range_rows).cast("int"), "_member": (at % range_rows).cast("int")})
    dealt = placed.repartitionByRange("range", "_member")
    dealt.select(*rows.columns, "_member", "range").sortWithinPartitions("range", "_member").write.partitionBy("range").parquet(f"{root}/rows")
    each = placed.select("range", "_member", F.explode(_grams(F.col("_text"))).alias("gram"))
    lists = each.groupBy("gram", "range").agg(F.sort_array(F.collect_list("_member")).alias("members")).withColumn("bucket", _bucket(F.col("gram")))
    ordered = lists.repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram", "range")
    ordered.select("gram", "range", "members", "bucket").write.partitionBy("bucket").parquet(f"{root}/grams")
    return TextIndex(spark, root, StructType([StructField(f.name, f.dataType) for f in rows.schema]))


def place_text() -> Column:
    """What a search of the municipality catalog looks at: code and key of the name."""
    return F.concat_ws(BETWEEN, "ibge_code", place_name_key(F.col("name")))


def registered_text() -> Column:
    return F.lower(F.concat_ws(BETWEEN, "ibge_code", "name"))


def catalog_text(fields: tuple[str, ...]) -> Column:
    return words_key(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))


def search_places(index: TextIndex, search: str, limit: int = 20) -> DataFrame:
    """:func:`geography.search_catalog` over an index of :func:`place_text`."""
    text = search.strip()
    if text.isdigit():
        return geography.search_catalog(index.candidates([text]), search, limit)
    wanted = evaluated(index.spark, place_name_key(F.coalesce(parse_place_name(F.lit(text))["name"], F.lit(text))))
    return geography.search_catalog(index.candidates([wanted or ""]), search, limit)


def search_registered(index: TextIndex, search: str = "", limit: int = 20) -> DataFrame:
    """:func:`geography.search_registered` over an index of :func:`registered_text`; the text may hold the wildcards of LIKE."""
    pieces = evaluated(index.spark, F.lower(F.lit(search.strip()))).replace("\\", "%").replace("_", "%").split("%")
    return geography.search_registered(index.candidates(pieces), search, limit)


def search_rows(index: TextIndex, query: str, fields: tuple[str, ...]) -> DataFrame:
    """:func:`filters.search_catalog_rows` over an index of :func:`catalog_text`."""
    words = evaluated(index.spark, words_key(F.lit(query))) or ""
    return filters.search_catalog_rows(index.candidates(words.split(" ")), query, fields)
