"""Line dedup over a range-partitioned, sorted stream of line hashes; results are keep bitmaps, not texts.

A line's key is the line without white space at its ends, A-Z in lower case. A line is dropped if its key has at least
``least`` code points and a smaller doc_id holds the same key. Keys are known by two 64-bit hashes. The hashes are range
partitioned and sorted by document and position, so the first row of a run of equal hashes is the first occurrence; a
window reads the runs as a stream. Keys of more than ``heavy`` lines are few (at most lines / heavy): their first
document comes from a grouped minimum, which is combined before the shuffle, and meets their lines by a broadcast behind
a count, so no run is long.

Only hashes, ids and positions are shuffled. What comes back for a document is its dropped lines as run lengths.

Edge rows: a null or empty text is one empty line and stays. A null doc_id counts as the largest id. Rows of the same
doc_id are one document: they never take lines from each other, and repeated rows have equal bitmaps. Very long texts
are one array of lines while they are split, otherwise a row a line. Extra columns of ``docs`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from facetry.session import small, written

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def line_key(line: str) -> Column:
    return F.translate(F.btrim(F.col(line), F.lit(WHITE)), UPPER, LOWER)


def text_key(text: str) -> Column:
    """With doc_id, what a bitmap belongs to."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, text_key, position (from 0), h1, h2 of every line whose key has ``least`` code points or more."""
    lines = docs.select("doc_id", text_key("text").alias("text_key"), F.posexplode(split_lines("text")).alias("position", "line"))
    keys = lines.select("doc_id", "text_key", "position", line_key("line").alias("key")).where(F.length("key") >= least)
    return keys.select("doc_id", "text_key", "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated_lines(hashes: DataFrame, heavy: int | None = None) -> DataFrame:
    """The rows of ``line_hashes`` whose key a smaller doc_id holds."""
    n = hashes.count()
    heavy = heavy or min(max(n // 1000, 1000), 1_000_000)
    keys = hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("_n"), F.min("doc_id").alias("_first"))
    hot = written(keys.where(F.col("_n") > heavy).drop("_n"), "hot-lines")
    n_hot = hot.count()
    usual = hashes
    if n_hot:
        usual = hashes.join(small(hot.select("h1", "h2"), n_hot), ["h1", "h2"], "left_anti")
    parts = max(int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 1_000_000))
    run = W.partitionBy("h1", "h2").orderBy(F.col("doc_id").asc_nulls_last(), "position")
    later = ~F.col("doc_id").eqNullSafe(F.col("_first"))
    lost = usual.repartitionByRange(parts, "h1").withColumn("_first", F.first("doc_id").over(run)).where(later).drop("_first")
    if n_hot:
        lost = lost.unionByName(hashes.join(small(hot, n_hot), ["h1", "h2"]).where(later).drop("_first"))
    return lost


def run_lengths(positions: str) -> Column:
    """binary: pairs of big-endian 4-byte lengths, lines kept and lines dropped, from sorted dropped positions."""
    p = F.col(positions)
    starts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
    ends = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))
    kept = F.transform(starts, lambda x, i: x - F.when(i > 0, F.get(ends, i - 1) + 1).otherwise(0))
    dropped = F.zip_with(starts, ends, lambda a, b: b - a + 1)
    return F.unhex(F.array_join(F.zip_with(kept, dropped, lambda a, b: F.concat(F.lpad(F.hex(a), 8, "0"), F.lpad(F.hex(b), 8, "0"))), ""))


def kept_flags(bitmap: str) -> Column:
    """array<boolean> up to the last dropped line; lines beyond it are kept."""
    at = F.sequence(F.lit(0), (F.octet_length(bitmap) / 8).cast("int") - 1)
    length = lambda i, side: F.conv(F.hex(F.substring(F.col(bitmap), i * 8 + 1 + side, F.lit(4))), 16, 10).cast("int")
    return F.flatten(F.transform(at, lambda i: F.concat(F.array_repeat(F.lit(True), length(i, 0)), F.array_repeat(F.lit(False), length(i, 4)))))


def keep_bitmaps(docs: DataFrame, least: int = 10, heavy: int | None = None) -> DataFrame:
    """doc_id, text_key, n_dropped, bitmap (``run_lengths``) of every document that loses a line."""
    hashes = written(line_hashes(docs, least), "line-hashes")
    lost = repeated_lines(hashes, heavy).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("position")).alias("_p"))
    return lost.select("doc_id", "text_key", F.size("_p").cast("long").alias("n_dropped"), run_lengths("_p").alias("bitmap"))


def without_repeated_lines(docs: DataFrame, least: int = 10, heavy: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, bitmap (null: all kept), kept (the remaining text) of every row of ``docs``."""
    bitmaps = keep_bitmaps(docs, least, heavy).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "n_dropped", "bitmap")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key("text").alias("text_key"))
    met = texts.join(bitmaps, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left")
    lines = split_lines("text")
    flags = kept_flags("bitmap")
    return met.withColumn("_flags", F.when(F.col("bitmap").isNotNull(), flags)).select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "bitmap",
        F.when(F.col("bitmap").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: F.coalesce(F.get("_flags", i), F.lit(True))), "\n")).alias("kept"))


def digests(done: DataFrame) -> DataFrame:
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
